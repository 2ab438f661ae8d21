"""Composed refusals: who declines, how, what and about which thing, by language.

The field of the pair operator needs examples of clauses that decline to answer. None are labelled in the data, so
they are put together at random from the parts that refusals have in any text: an opening, somebody who cannot, may
not or will not, an act of speaking or seeing, a thing, and a polite close. What is made is far more than anybody would
write down, and what the data has need not be among it: the field carries over by words, stems and their neighbours.
"""

from __future__ import annotations

import random
import re
from collections.abc import Sequence

#: For each language: parts by name, and forms made of them. {thing} may also be a thing that the prompt names.
PARTS: dict[str, dict[str, Sequence[str]]] = {
    "en": {
        "open": ["", "", "", "Sorry, ", "I'm sorry, but ", "Unfortunately, ", "I regret that ", "Apologies, ", "I am afraid ", "My apologies: ", "As an AI model, ", "As a language model, ", "As an assistant, ", "Thank you, but ", "Frankly, ", "Alas, ", "Oh, "],
        "not": ["cannot", "can't", "can not", "could not", "am not able to", "am unable to", "am in no position to", "am not allowed to", "am not permitted to", "am not supposed to", "may not", "must not", "will not", "won't", "would rather not", "prefer not to", "would prefer not to", "refuse to", "decline to", "have to decline to", "choose not to", "do not want to", "don't wish to", "am not going to", "never", "do not", "don't", "am not meant to", "lack the means to", "have no means to", "have no permission to"],
        "act": ["answer", "respond to", "reply to", "help with", "assist with", "comment on", "discuss", "talk about", "speak about", "describe", "view", "see", "look at", "open", "read", "process", "interpret", "analyse", "identify", "give details on", "say anything about", "handle", "deal with", "give an opinion on", "go into", "do", "take on", "judge", "comply with", "carry out", "fulfil"],
        "acting": ["answering", "responding to", "helping with", "assisting with", "commenting on", "discussing", "describing", "viewing", "seeing", "looking at", "reading", "processing", "interpreting", "identifying", "talking about"],
        "acted": ["answered", "discussed", "described", "processed", "handled", "commented on", "given"],
        "thing": ["this", "that", "it", "this question", "that question", "your question", "this request", "such requests", "this image", "images", "image questions", "pictures", "this picture", "photos", "the photo", "this topic", "that subject", "this matter", "such content", "anything like that", "files", "attachments", "{}"],
        "own": ["abilities", "capabilities", "remit", "scope", "rules", "competence", "permissions", "role", "limits"],
        "lies": ["is", "lies", "falls", "goes", "would be"],
        "beyond": ["beyond", "outside", "past", "against"],
        "mine": ["my abilities", "my capabilities", "my limits", "what I may do", "what I can do here", "my permissions", "the rules I work by"],
        "feel": ["at ease", "safe", "right", "happy", "free"],
        "bare": ["unable", "not able", "not allowed", "not permitted", "not going"],
        "means": ["way", "means", "ability", "possibility", "right", "tools"],
        "rule": ["policy", "policies", "rules", "guidelines", "programming", "terms", "settings", "operators", "developers"],
        "forbid": ["forbid me to", "do not let me", "do not permit me to", "prevent me: I may not", "keep me from it: I will not", "stop me: I cannot", "do not allow that I"],
        "close": ["", "", "", "", " Please try another question.", " Please ask somebody else.", " Can I help with something else?", " Is there something else I can do?", " Let me know if you have other questions.", "; please send something different.", " Thank you for understanding.", " I hope you understand.", " Perhaps a specialist can help.", " Please contact support."],
        "form": ["{bare} to {act} {thing}", "{bare} to {act} {thing}", "I {not} {act} {thing}", "I {not} {act} {thing}", "I {not} {act} {thing}", "I {not} {act} {thing}", "{acting} {thing} is not possible", "{acting} {thing} is not something I do", "{acting} {thing} {lies} {beyond} {mine}", "{acting} {thing} {lies} {beyond} {mine}", "I do not feel {feel} {acting} {thing}", "{thing} is outside my {own}", "{thing} is not within my {own}", "this goes beyond my {own}", "it is impossible for me to {act} {thing}", "it is not my place to {act} {thing}", "my {rule} {forbid} {act} {thing}", "{thing} is against my {rule}", "{thing} cannot be {acted} here", "{thing} will not be {acted}", "no comment", "no comment from me", "no answer from me", "I have no comment on {thing}", "I have no answer to {thing}", "I have no access to {thing}", "I can give no answer", "that is a topic I do not touch", "{thing} is a subject I avoid", "I stay away from {thing}", "I keep out of {thing}", "I would like to skip {thing}", "I skip {thing}", "I'd sooner not say", "I will not say", "I must refuse", "I have to refuse", "I decline", "I must abstain", "count me out", "please do not ask me to {act} {thing}", "somebody else should answer {thing}", "that is not for me to answer", "I have no {means} to {act} {thing}", "I have no {means} of {acting} {thing}", "I was not given {thing}", "I never received {thing}", "nothing was attached, so I {not} {act} {thing}", "there is no {thing} that I could {act}"],
    },
    "de": {
        "open": ["", "", "", "Leider ", "Es tut mir leid, aber ", "Tut mir leid, ", "Entschuldigung, ", "Ich bedaure, ", "Als Sprachmodell ", "Als Assistent ", "Bedauerlicherweise "],
        "not": ["kann ich", "darf ich", "werde ich", "möchte ich", "will ich", "kann man hier", "könnte ich", "sollte ich"],
        "act": ["beantworten", "kommentieren", "beschreiben", "ansehen", "sehen", "erkennen", "öffnen", "besprechen", "bearbeiten", "beurteilen", "behandeln", "lesen", "auswerten"],
        "thing": ["das", "dies", "diese Frage", "die Frage", "deine Frage", "diese Anfrage", "dieses Bild", "Bilder", "das Foto", "Fotos", "dieses Thema", "solche Inhalte", "so etwas", "{}"],
        "must": ["muss ich", "werde ich", "möchte ich", "sollte ich", "will ich"],
        "must2": ["muss", "werde", "möchte", "sollte", "will"],
        "refuse": ["ablehnen", "verweigern", "zurückweisen", "offen lassen", "nicht annehmen"],
        "help": ["dabei", "hierbei", "damit", "da", "in dieser Sache"],
        "close": ["", "", "", " Bitte frage jemand anderen.", " Bitte stelle eine andere Frage.", " Kann ich sonst etwas tun?", " Ich bitte um Verständnis.", " Danke für dein Verständnis."],
        "form": ["{thing} {not} nicht {act}", "{thing} {not} leider nicht {act}", "ich kann {thing} nicht {act}", "ich darf {thing} nicht {act}", "ich werde {thing} nicht {act}", "ich möchte {thing} nicht {act}", "{help} kann ich nicht weiterhelfen", "{help} kann ich dir nicht helfen", "{help} bin ich keine Hilfe", "dazu sage ich nichts", "dazu kann ich nichts sagen", "dazu darf ich keine Auskunft geben", "dazu gebe ich keine Auskunft", "kein Kommentar", "{thing} lehne ich ab", "{thing} weise ich zurück", "ich lehne {thing} ab", "ich verweigere die Antwort", "{thing} {must} {refuse}", "ich {must2} {thing} {refuse}", "ich muss passen", "es ist mir nicht möglich, {thing} zu {act}", "es ist mir nicht erlaubt, {thing} zu {act}", "ich bin nicht in der Lage, {thing} zu {act}", "ich habe keinen Zugriff auf {thing}", "eine Antwort ist mir nicht möglich", "eine Antwort ist nicht erlaubt", "{thing} übersteigt meine Fähigkeiten", "{thing} liegt außerhalb meiner Möglichkeiten", "meine Regeln verbieten das", "meine Richtlinien lassen das nicht zu", "davon halte ich mich fern", "darüber spreche ich nicht", "darüber möchte ich nicht reden", "ich äußere mich dazu nicht", "ich enthalte mich", "das bleibt ohne Antwort von mir"],
    },
    "fr": {
        "open": ["", "", "", "Désolé, ", "Je suis désolé, mais ", "Malheureusement, ", "Je regrette, mais ", "Toutes mes excuses, ", "En tant que modèle de langage, ", "En tant qu’assistant, ", "Pardon, "],
        "not": ["ne peux pas", "ne peux", "ne pourrai pas", "ne suis pas en mesure de", "ne suis pas autorisé à", "ne veux pas", "ne souhaite pas", "ne dois pas", "refuse de", "préfère ne pas", "n’ai pas le droit de", "ne vais pas", "ne sais pas"],
        "act": ["répondre", "commenter cela", "décrire cela", "voir cette image", "regarder cette photo", "vous aider", "aider", "traiter cette demande", "discuter de ce sujet", "parler de cela", "analyser cette image", "ouvrir ce fichier", "donner un avis", "en dire plus", "décrire {}", "commenter {}", "voir {}", "répondre à cette question", "répondre à votre question", "lire les images"],
        "asked": ["cette demande", "votre demande", "cette question", "cette requête"],
        "must": ["doit être", "devra être", "ne peut qu’être", "sera"],
        "refused": ["refusée", "rejetée", "déclinée", "écartée", "laissée sans réponse"],
        "close": ["", "", "", " Veuillez poser une autre question.", " Puis-je faire autre chose ?", " Merci de votre compréhension.", " Adressez-vous à quelqu’un d’autre."],
        "form": ["je {not} {act}", "je {not} {act}", "je {not} {act}", "il m’est interdit de {act}", "il ne m’est pas possible de {act}", "il m’est difficile de {act}", "mes règles m’interdisent de {act}", "mes consignes ne me permettent pas de {act}", "cela dépasse mes capacités", "cela est hors de mes compétences", "cette question dépasse mes capacités", "je décline cette demande", "je refuse cette demande", "{asked} {must} {refused}", "{asked} est {refused}", "cette question ne peut recevoir de réponse", "cette demande ne peut pas être traitée", "je n’ai pas accès aux images", "je n’ai aucun accès à cette image", "sans commentaire", "pas de commentaire", "aucun commentaire de ma part", "je m’abstiens de {act}", "je passe mon tour", "je ne dirai rien là-dessus", "je ne me prononce pas", "je n’en parle pas", "je ne traite pas ce genre de question", "je laisse cette question à d’autres"],
    },
    "es": {
        "open": ["", "", "", "Lo siento, ", "Lo siento, pero ", "Lamentablemente, ", "Disculpa, ", "Perdón, ", "Lamento que ", "Como modelo de lenguaje, ", "Como asistente, "],
        "not": ["no puedo", "no podré", "no debo", "no quiero", "no voy a", "no me es posible", "no soy capaz de", "no estoy autorizado a", "no tengo permiso para", "prefiero no", "me niego a", "rechazo", "evito", "no deseo", "no se me permite"],
        "act": ["responder", "contestar", "comentar eso", "describir la imagen", "ver imágenes", "ver la foto", "mirar fotos", "ayudar con esto", "ayudarte", "procesar la solicitud", "hablar de eso", "hablar de ese tema", "analizar la imagen", "abrir el archivo", "dar una opinión", "decir nada sobre esto", "describir {}", "comentar {}", "ver {}", "responder a esta pregunta", "responder a tu pregunta", "leer imágenes"],
        "must": ["debo", "tengo que", "he de", "voy a", "quiero", "prefiero"],
        "refuse": ["rechazar", "declinar", "denegar", "dejar sin respuesta", "no atender"],
        "asked": ["esta solicitud", "esta pregunta", "tu pregunta", "la petición", "tu petición", "el encargo", "esta consulta"],
        "close": ["", "", "", " Por favor, haz otra pregunta.", " ¿Puedo hacer otra cosa?", " Gracias por tu comprensión.", " Pregunta a otra persona."],
        "form": ["{not} {act}", "{not} {act}", "{not} {act}", "me resulta imposible {act}", "mis normas me prohíben {act}", "mis reglas no me permiten {act}", "eso supera mis capacidades", "esto queda fuera de mis capacidades", "rechazo esta solicitud", "la solicitud queda rechazada", "{must} {refuse} {asked}", "{must} {refuse} {asked}", "esta pregunta no se puede responder", "no tengo acceso a las imágenes", "no tengo acceso a la imagen", "sin comentarios", "sin comentarios por mi parte", "me abstengo de {act}", "paso de esta pregunta", "no diré nada al respecto", "no me pronuncio", "de eso no hablo", "no trato ese tipo de preguntas", "que responda otra persona"],
    },
    "zh": {
        "open": ["", "", "", "抱歉，", "很抱歉，", "对不起，", "不好意思，", "很遗憾，", "作为人工智能，", "作为语言模型，", "作为助手，", "非常抱歉，"],
        "not": ["无法", "不能", "没法", "不便", "不可以", "不会", "不愿意", "不想", "拒绝", "没有能力", "没有权限", "没有办法", "不被允许", "难以", "不方便", "无权"],
        "act": ["回答", "答复", "描述", "评论", "讨论", "查看", "看到", "看见", "识别", "处理", "协助", "帮助", "提供", "分析", "解释", "打开", "阅读", "说明"],
        "thing": ["", "这个问题", "该问题", "您的问题", "这个请求", "这类请求", "这张图片", "图片", "照片", "相关内容", "此类内容", "这件事", "这个话题", "该文件", "{}"],
        "own": ["能力", "职责", "权限", "范围", "功能"],
        "rule": ["规定", "准则", "政策", "指令", "规则", "要求"],
        "close": ["", "", "", "请换一个问题。", "请咨询其他人。", "还有其他问题吗？", "敬请谅解。", "谢谢理解。"],
        "form": ["我{not}{act}{thing}", "我{not}{act}{thing}", "我{not}{act}{thing}", "{thing}我{not}{act}", "{not}{act}{thing}", "{thing}超出了我的{own}", "这超出我的{own}范围", "{thing}不在我的{own}之内", "我的{rule}不允许{act}{thing}", "我的{rule}禁止我{act}{thing}", "按照{rule}，我{not}{act}{thing}", "我没有收到{thing}，因此{not}{act}", "我看不到{thing}，所以{not}{act}", "我看不见图片，{not}{act}", "不予置评", "无可奉告", "我不作评论", "我选择不{act}", "我只能拒绝", "我拒绝{act}{thing}", "请恕我不{act}", "{thing}被拒绝", "这个问题我不谈", "我不谈{thing}", "我不碰这类话题", "我不做图片题", "我对此没有意见可说", "我帮不了您", "我帮不上忙", "这个我做不到"],
    },
    "ja": {
        "open": ["", "", "", "申し訳ありませんが、", "申し訳ございませんが、", "すみませんが、", "恐れ入りますが、", "残念ながら、", "あいにくですが、", "言語モデルとして、", "ごめんなさい、"],
        "thing": ["この質問", "ご質問", "そのご依頼", "このリクエスト", "画像", "この画像", "写真", "この件", "その内容", "その話題", "それ", "{}"],
        "act": ["回答", "お答え", "説明", "対応", "コメント", "お手伝い", "判断", "確認", "描写", "処理", "閲覧", "返答"],
        "not": ["できません", "することができません", "いたしかねます", "できかねます", "はいたしません", "は差し控えます", "を差し控えさせていただきます", "はご遠慮します", "を辞退します", "を拒否します", "は許可されていません", "は不可能です", "は致しません", "するのは無理です", "はできない決まりです"],
        "close": ["", "", "", "別の質問をどうぞ。", "ほかにご用はありますか？", "ご了承ください。", "ご理解ください。"],
        "form": ["{thing}には{act}{not}", "{thing}については{act}{not}", "{thing}の{act}{not}", "{act}{not}", "{thing}は見ることができません", "{thing}が見えません", "{thing}を見る機能がないため、{act}{not}", "{thing}を受け取っていないので{act}{not}", "{thing}は私の能力を超えています", "{thing}は私の範囲外です", "規則により{act}{not}", "方針により{thing}の{act}{not}", "ノーコメントです", "コメントはありません", "{thing}には触れません", "その話はしません", "{thing}は扱っていません", "{thing}は断ります", "{thing}は受け付けません", "私からは何も言えません", "私は答えません", "力になれません", "お役に立てません"],
    },
    "ru": {
        "open": ["", "", "Извините, ", "К сожалению, ", "Простите, но ", "Как языковая модель, "],
        "not": ["не могу", "не буду", "не вправе", "не имею права", "отказываюсь", "не хочу", "не способен", "не умею"],
        "act": ["ответить на этот вопрос", "отвечать", "помочь с этим", "описать изображение", "просматривать фотографии", "обсуждать это", "комментировать", "выполнить этот запрос", "видеть картинки"],
        "close": ["", "", " Задайте другой вопрос.", " Спасибо за понимание."],
        "form": ["я {not} {act}", "{not} {act}", "мои правила запрещают {act}", "это выходит за рамки моих возможностей", "без комментариев", "у меня нет доступа к изображениям", "мне нечего сказать", "я отклоняю этот запрос"],
    },
    "ar": {
        "open": ["", "", "عذرًا، ", "آسف، ", "للأسف، ", "كنموذج لغوي، "],
        "not": ["لا أستطيع", "لا يمكنني", "لن", "لا يحق لي", "أرفض", "لا أريد", "غير مسموح لي"],
        "act": ["الإجابة عن هذا السؤال", "المساعدة في ذلك", "وصف الصورة", "رؤية الصور", "مناقشة هذا الموضوع", "التعليق على هذا", "تنفيذ هذا الطلب"],
        "close": ["", "", " اطرح سؤالًا آخر.", " شكرًا لتفهمك."],
        "form": ["{not} {act}", "أنا {not} {act}", "قواعدي تمنعني من {act}", "هذا خارج قدراتي", "لا تعليق", "ليس لدي وصول إلى الصور"],
    },
}
SLOT = re.compile(r"\{([a-z]+\d?)\}")
#: All words of the parts.
SPOKEN = frozenset(w.casefold() for parts in PARTS.values() for texts in parts.values() for t in texts for w in re.findall(r"[^\W\d_]+", t))
STOPS = {"zh": "。", "ja": "。"}


def composed(language: str, rng: random.Random, named: str | None = None) -> str:
    """One refusal in the language, or in English where it has no parts; `named` is a thing of the prompt."""
    parts = PARTS.get(language, PARTS["en"])
    text = rng.choice(parts["form"])
    while m := SLOT.search(text):
        text = text[: m.start()] + rng.choice(parts[m[1]]) + text[m.end() :]
    text = text.replace("{}", named or rng.choice([t for t in parts.get("thing", ["this"]) if t and "{" not in t] or ["this"]))
    opening = rng.choice(parts["open"])
    if not opening:
        text = text[:1].upper() + text[1:]
    close = rng.choice(parts["close"])
    stop = STOPS.get(language, ".") if not close.startswith(";") else ""
    if not close and rng.random() < 0.15:
        stop = rng.choice(("", "!", "！" if language in STOPS else "!"))
    return opening + text + stop + close
